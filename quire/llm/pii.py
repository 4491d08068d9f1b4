"""Personal data in whole texts, by Spark SQL functions alone.

Base spans come from fixed patterns and checks. Further candidates come from one wide pattern; regex,
gazetteer, context and shape labelers vote on each (1, 0 or abstain). Expectation-maximisation over the
counts of vote patterns (at most 3 to the number of labelers for each kind) estimates every labeler's
reliability, its posteriors train a span classifier on features of the candidates, and the classifier's
spans join the base ones. All spans are code points, end exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import materialize

#: Fixed patterns, in an equivalent form that scans in linear time without recursion: a match can only
#: begin where its first run begins (or where the last match ended), and runs are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "contains(t, '@')", "ip": "d", "card": "d", "phone": "contains(t, '+')"}
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = (
    f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> if(i % 2 = 0, cast(c as int), cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0))), 0, (a, v) -> a + v) % 10 = 0"
)
CHECKS = {
    "email": "true",
    "ip": r"x.m rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$'",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) between 8 and 15",
}
#: What the candidates look like; alternatives in the order of WIDE_KINDS.
WIDE = {
    "secret": r"(?:[0-9A-Fa-f]{32,}+|(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abps]|AKIA|ASIA|AIza)[A-Za-z0-9_-]{16,}+|[A-Za-z0-9+/_-]{40,}+={0,2}+)(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "phone": r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9-])",
    "email": r"[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
}
WIDE_PATTERN = "(?<![A-Za-z0-9._%+-])(?:" + "|".join(f"{p}" for p in WIDE.values()) + ")"
KINDS = ["email", "ip", "card", "phone", "iban", "secret", "ssn"]
#: Code points of context before and after a candidate.
CONTEXT = 40

#: Word lists of the gazetteer and context labelers.
NEAR = {
    "secret": "token|secret|key|password|passwd|credential|auth|bearer|api",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|telefon|handy",
    "email": "mail|email|contact|write|reach",
}
AGAINST = "sha|md5|hash|commit|checksum|digest|isbn|order|invoice|version|page|serial|part|figure|table"
IBAN_LANDS = "DE|FR|ES|IT|NL|BE|AT|CH|GB|IE|PT|PL|SE|DK|FI|NO|LU|CZ|GR|HU|RO"
_IBAN = "regexp_replace(x.m, ' ', '')"
#: An account number's check: its letters as two digits, the first four characters last, leave 1 of 97.
_MOD_97 = f"aggregate(split(concat(substr({_IBAN}, 5), left({_IBAN}, 4)), ''), 0, (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"
_SECRET = "case when x.m rlike '^[0-9A-Fa-f]+$' then if(x.m rlike '[0-9]' and x.m rlike '[A-Fa-f]' and length(x.m) % 8 = 0, 1, 0) when x.m rlike '^(sk|pk|rk|gh|glpat|xox|AKIA|ASIA|AIza)' then 1 else if(x.m rlike '[0-9]' and x.m rlike '[A-Z]' and x.m rlike '[a-z]', 1, 0) end"
#: Votes of the labelers on a candidate x (k: kind, m: text, b: before, a: after): 1, 0, or null to abstain.
LABELERS = {
    "regex": f"case x.k when 'secret' then {_SECRET} when 'iban' then if({_MOD_97}, 1, 0) when 'ssn' then if(x.m rlike '^(000|666|9)', 0, 1) when 'phone' then if(regexp_replace(x.m, '[^0-9]', '') rlike '^[2-9]', 1, 0) when 'email' then if(x.m rlike '[A-Za-z]{{2,6}}$', 1, 0) end",
    "gazetteer": f"case when x.k = 'iban' then if(x.m rlike '^({IBAN_LANDS})', 1, 0) " + " ".join(f"when x.k = '{k}' and lower(x.b) rlike '(^|[^a-z])({w})[^a-z]*$' then 1" for k, w in NEAR.items() if k != "iban") + " end",
    "context": f"case when lower(x.b) rlike '(^|[^a-z])({AGAINST})[^a-z]*$' then 0 " + " ".join(f"when x.k = '{k}' and lower(x.b) rlike '({w})' then 1" for k, w in NEAR.items()) + " end",
    "mark": r"""case when x.b rlike r'[:=]\s*["(\[]?$' then 1 when x.b rlike r'[#/\\]$' then 0 end""",
    "shape": "if(size(array_distinct(split(x.m, ''))) >= 6, 1, 0)",
}
#: What is believed of each labeler beforehand: its chance of a 1 (where it votes) among true and among false
#: spans, and how many spans that belief is worth. Shapes pass on most false spans too; context seldom does.
BELIEFS = {"regex": (0.95, 0.7), "gazetteer": (0.9, 0.1), "context": (0.9, 0.1), "mark": (0.9, 0.3), "shape": (0.95, 0.7)}
STRENGTH = 20.0
#: What the span classifier sees of a candidate, besides its votes.
FEATURES = {
    "length": "cast(least(log2(length(x.m)), 7) as int)",
    "digits": "cast(4 * length(regexp_replace(x.m, '[^0-9]', '')) / length(x.m) as int)",
    "left": r"case when x.b = '' then 0 when x.b rlike r'\s$' then 1 when x.b rlike r'[\"(\[]$' then 2 else 3 end",
    "right": r"case when x.a = '' then 0 when x.a rlike r'^\s' then 1 when x.a rlike r'^[\".,;)\]]' then 2 else 3 end",
}


def located(pattern: str) -> str:
    """SQL: the matches of ``pattern`` in t, as an array of (m, s, e, b, a): text, span, text around.

    ``split`` and ``regexp_extract_all`` find the same matches; their lengths add up to positions, in
    blocks of 64 so that many matches stay cheap.
    """
    start, size_ = "u.p + length(get(q.p, i))", "length(get(q.m, i))"
    block = (
        f"aggregate(sequence(g * 64, least(g * 64 + 63, size(q.m) - 1)), named_struct('p', 0, 'o', array_repeat(named_struct('m', '', 's', 0, 'e', 0, 'b', '', 'a', ''), 0)), "
        f"(u, i) -> named_struct('p', {start} + {size_}, 'o', concat(u.o, array(named_struct('m', get(q.m, i), 's', {start}, 'e', {start} + {size_}, 'b', right(get(q.p, i), {CONTEXT}), 'a', left(get(q.p, i + 1), {CONTEXT}))))))"
    )
    shift = "transform(y.o, z -> named_struct('m', z.m, 's', z.s + v.p, 'e', z.e + v.p, 'b', z.b, 'a', z.a))"
    whole = f"aggregate(transform(sequence(0, (size(q.m) - 1) div 64), g -> {block}), named_struct('p', 0, 'o', array_repeat(named_struct('m', '', 's', 0, 'e', 0, 'b', '', 'a', ''), 0)), (v, y) -> named_struct('p', v.p + y.p, 'o', concat(v.o, {shift})), v -> v.o)"
    none = "array_repeat(named_struct('m', '', 's', 0, 'e', 0, 'b', '', 'a', ''), 0)"
    return f"element_at(transform(array(named_struct('m', regexp_extract_all(t, r'{pattern}', 0), 'p', split(t, r'{pattern}', -1))), q -> if(size(q.m) = 0, {none}, {whole})), 1)"


def find(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, base (kind, start, end), found (the candidates, with their votes and features).

    Null texts count as empty; other columns are ignored. Candidates that overlap a base span are left out, which
    takes time in proportion to a text's candidates times its base spans.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("d", F.expr("t rlike '[0-9]'"))
    base = [f"if({NEEDS[k]}, transform(filter({located(p)}, x -> {CHECKS[k]}), x -> named_struct('k', '{k}', 's', x.s, 'e', x.e)), array_repeat(named_struct('k', '', 's', 0, 'e', 0), 0))" for k, p in PATTERNS.items()]
    rows = rows.withColumn("base", F.expr(f"concat({', '.join(base)})"))
    kind = "case " + " ".join(f"when x.m rlike r'^{WIDE[k]}$' then '{k}'" for k in WIDE) + " end"
    cands = f"if(d or contains(t, 'at'), transform({located(WIDE_PATTERN)}, x -> named_struct('k', {kind}, 'm', x.m, 's', x.s, 'e', x.e, 'b', x.b, 'a', x.a)), array_repeat(named_struct('k', '', 'm', '', 's', 0, 'e', 0, 'b', '', 'a', ''), 0))"
    rows = rows.withColumn("c", F.expr(cands))
    votes = ", ".join(f"coalesce({v}, 2)" for v in LABELERS.values())
    seen = ", ".join(f"concat('{n}=', {v})" for n, v in FEATURES.items())
    free = "filter(c, x -> x.k is not null and not exists(base, y -> y.s < x.e and x.s < y.e))"
    return rows.select("doc_id", "base", F.expr(f"transform({free}, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'v', concat({votes}), 'f', array({seen})))").alias("found"))


def reliabilities(patterns: dict[str, float], rounds: int = 30) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Posterior of each vote pattern, and each labeler's chance of a 1 among true and among false spans.

    ``patterns``: how often each string of votes (1, 0, 2 for abstain) occurs. Starts from the beliefs,
    which also stay as so many spans seen beforehand.
    """
    rates, prior, posterior = list(BELIEFS.values()), 0.5, {}
    for _ in range(rounds):
        for v in patterns:
            odds = math.log(prior / (1 - prior))
            for c, (t, f) in zip(v, rates, strict=True):
                odds += {"1": math.log(t / f), "0": math.log((1 - t) / (1 - f)), "2": 0.0}[c]
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        prior = (STRENGTH / 2 + sum(n * posterior[v] for v, n in patterns.items())) / (STRENGTH + sum(patterns.values()))
        rates = []
        for j, (t, f) in enumerate(BELIEFS.values()):
            voted = [(v[j] == "1", n, posterior[v]) for v, n in patterns.items() if v[j] != "2"]
            true, false = sum(n * p for _, n, p in voted), sum(n * (1 - p) for _, n, p in voted)
            rates.append(((STRENGTH * t + sum(n * p for one, n, p in voted if one)) / (STRENGTH + true), (STRENGTH * f + sum(n * (1 - p) for one, n, p in voted if one)) / (STRENGTH + false)))
    return posterior, rates


def train(found: DataFrame) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """The span classifier: posteriors by kind and votes, and weights by kind and feature.

    The weights are log ratios of soft counts under the posteriors; only sums by vote pattern and by
    feature value, both bounded by the labelers and features, reach the driver.
    """
    each = found.select(F.explode("found").alias("x")).select("x.k", "x.v", "x.f")
    counts: dict[str, dict[str, float]] = defaultdict(dict)
    for r in each.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.k][r.v] = float(r.n)
    posterior = {f"{k}{v}": p for k, by in counts.items() for v, p in reliabilities(by)[0].items()}
    weights: dict[str, dict[str, float]] = defaultdict(dict)
    soft: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    sums: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for r in each.select("k", "v", F.explode("f").alias("f")).groupBy("k", "v", "f").agg(F.count(F.lit(1)).alias("n")).collect():
        p = posterior[f"{r.k}{r.v}"]
        sums[r.k, r.f][0] += r.n * p
        sums[r.k, r.f][1] += r.n * (1 - p)
    for k, by in counts.items():
        for v, n in by.items():
            soft[k][0] += n * posterior[f"{k}{v}"]
            soft[k][1] += n * (1 - posterior[f"{k}{v}"])
    for (k, f), (yes, no) in sums.items():
        weights[k][f] = math.log((yes + 1) / (soft[k][0] + 2) * (soft[k][1] + 2) / (no + 1)) / len(FEATURES)
    return posterior, weights


def detect(docs: DataFrame) -> DataFrame:
    """All spans of each row of ``docs`` (doc_id, text): doc_id, base and all_spans.

    Both are arrays of (k, s, e): by kind in the order of ``KINDS``, then start. Base spans always stay; a
    candidate joins them where the classifier's odds are even or better. Null and empty texts have no
    spans; repeated rows are treated alike; an empty table gives an empty result.
    """
    found = materialize(find(docs), "spans")
    posterior, weights = train(found)
    odds = {f"{k}": math.log(max(p, 1e-9) / max(1 - p, 1e-9)) for k, p in posterior.items()}
    odds |= {f"{k}|{f}": w for k, by in weights.items() for f, w in by.items()}
    table = "map(" + ", ".join(f"{k!r}, {w!r}D" for k, w in sorted(odds.items())) + ")" if odds else "map('', 0.0D)"
    rank = f"array_position(array({', '.join(f'{k!r}' for k in KINDS)}), x.k)"
    score = "coalesce(get(w, concat(x.k, x.v)), 0.0D)".replace("get(", "try_element_at(") + " + aggregate(x.f, 0.0D, (a, f) -> a + coalesce(try_element_at(w, concat(x.k, '|', f)), 0.0D))"
    more = f"element_at(transform(array({table}), w -> transform(filter(found, x -> {score} >= 0), x -> named_struct('k', x.k, 's', x.s, 'e', x.e))), 1)"
    ordered = f"transform(array_sort(transform(concat(base, more), x -> named_struct('r', {rank}, 's', x.s, 'e', x.e, 'k', x.k))), x -> named_struct('k', x.k, 's', x.s, 'e', x.e))"
    return found.withColumn("more", F.expr(more)).select("doc_id", "base", F.expr(ordered).alias("all_spans"))


def digest(spans: str) -> str:
    """SQL: an array of spans as kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, x -> concat_ws(':', x.k, x.s, x.e)), ',')"
