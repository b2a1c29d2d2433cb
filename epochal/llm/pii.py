"""Personal data: candidates, boosted trees, calibrated thresholds.

High-recall generators propose overlapping spans: long tokens, runs of digits,
and the stretches of whole digit groups within such a run that are as long as a
card or a phone number. Gradient-boosted trees, one set a kind, score each by
its format and context; the scores are calibrated against held-out candidates.

The trees learn from evidence that is not among their inputs: check digits, a
plus sign, a word or a valid shape for a phone, key prefixes and names of secrets before a
token, against plain words, identifiers, dates, short or unseparated numbers, parts of
tokens and runs that fail their check digit. So they say how often tokens of such a format are real,
also where no evidence stands beside them. Every candidate is scored by the trees and
the evidence multiplies their odds: prefixes, names and phone shapes by ``RATIO``, what
speaks against a candidate by its inverse, and a check digit, which passes one time in
ten by chance, by ten. Trees are no surer than their held-out candidates let them be.
Spans whose probability is over the threshold are added to the base spans, which always
stay.

The sample is bounded and of distinct texts: a third of ``sample_docs`` each of
texts with named or prefixed secrets, with numbers and with long words, the
first by hash; of their candidates the first ``QUOTA`` of each kind and label
are used, and of the fixed ``seeds`` the same, so that any corpus has both.

Null texts are empty; repeated rows give repeated results; texts may have any
length, and one run of characters too; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, small_batches, table, written

# The base patterns, in the order of their kinds. An ip's match can only
# begin where its digits do, so it looks for no other place.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*BASE, "secret", "number"]
GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9_\-])(?=[0-9_\-]*[A-Za-z])[A-Za-z0-9_\-]{16,}"),
    "number": re.compile(r"(?<![0-9])\(?[0-9][0-9 ().-]{6,}[0-9](?![0-9])"),
}
GROUP = re.compile(r"\(?[0-9]+\)?")
KEYED = re.compile(r"(?:token|secret|key|password|passwd|pwd|auth)\s*[=:]\s*[\"']?$", re.I)
PREFIXED = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|sk-|npm_|hf_|SG_|eyJ)[A-Za-z0-9_\-]{10,}")
PLAIN = re.compile(r"[_-]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4})(?:[_-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))*[_-]*")
PHONE = re.compile(r"(?:1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}")
CALLED = re.compile(r"\b(?:tel|phone|telephone|mobile|cell|fax|call)\s*[.:=]?\s*[\"']?$", re.I)
DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]|[0-3]?[0-9][ .-][0-3]?[0-9][ .-](?:19|20)[0-9]{2})(?:[ .-][0-9]{1,2}){0,3}")
QUOTA = 400
CHANCE = 0.1  # a random run passes its check digit so often
RATIO = 300.0  # of the odds with evidence to those without


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of the pattern, looked for around each @ so that long runs of letters
    are read once: the characters before it back to the match before, then the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at > end and text[at - 1] in LOCALS and (m := DOMAIN.match(text, at + 1)):
            start = at - 1
            while start > end and text[start - 1] in LOCALS:
                start -= 1
            out.append((start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(s, 0, e) for s, e in emails(text)]
    return out + [(m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) if k for m in p.finditer(text) if valid(kind, m[0])]


def stretches(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """The run itself, and its stretches of whole groups with 9 to 19 digits."""
    groups = [(s + m.start(), s + m.end(), sum(map(str.isdigit, m[0]))) for m in GROUP.finditer(text[s:e])]
    out = [(s, e)]
    for i, (start, _, _) in enumerate(groups):
        digits = 0
        for j in range(i, min(i + 19, len(groups))):  # a group has a digit at least
            _, end, n = groups[j]
            digits += n
            if digits > 19:
                break
            if digits >= 9:
                out.append((start, end))
    return list(dict.fromkeys(out))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = [(m.start(), 4, m.end()) for m in GENERATORS["secret"].finditer(text)]
    found += [(s, 5, e) for m in GENERATORS["number"].finditer(text) for s, e in stretches(text, m.start(), m.end())]
    if not taken:
        return found
    starts, ends = zip(*sorted((a, b) for a, _, b in taken), strict=True)
    ends = list(accumulate(ends, max))  # the furthest end of the spans up to each
    return [(s, k, e) for s, k, e in found if not (i := bisect_left(starts, e)) or ends[i - 1] <= s]


def described(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context features of a candidate, none of which is evidence."""
    s, kind, e = span
    found, before, after = text[s:e], text[s - 1 : s], text[e : e + 1]
    n = len(found)
    digits, letters = sum(c.isdigit() for c in found), sum(c.isalpha() for c in found)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(found, found[1:], strict=False))
    row = [n, digits / n, switches / n, float(before in "\"'" and before != "")]
    if KINDS[kind] == "secret":
        upper, vowels = sum(c.isupper() for c in found), sum(c in "aeiouAEIOU" for c in found)
        return [*row, len(set(found)) / n, letters / n, upper / n, vowels / n, (n - digits - letters) / n, max(map(len, re.split("[^A-Za-z]", found))) / n, float(bool(re.fullmatch("[0-9a-fA-F]+", found)))]
    groups = [len(x) for x in re.findall("[0-9]+", found)]
    return [*row, digits, len(groups), max(groups), min(groups), float("(" in found), found.count("."), found.count("-"), float(before.isalnum()), float(after.isalnum())]


def weak_label(text: str, span: tuple[int, int, int]) -> int | None:
    """1 or 0 where there is evidence for or against, else unknown."""
    s, kind, e = span
    found = text[s:e]
    if KINDS[kind] == "secret":
        if PREFIXED.fullmatch(found) or KEYED.search(text[max(0, s - 24) : s]):
            return 1
        return 0 if PLAIN.fullmatch(found) else None
    digits = re.sub("[^0-9]", "", found)
    if len(digits) < 9 or len(digits) > 19 or DATE.fullmatch(found) or text[s - 1 : s].isalnum() or text[e : e + 1].isalnum():
        return 0
    if is_phone(text, span):
        return 1
    if len(digits) >= 14:
        return int(luhn(digits))
    return 0 if found.isdigit() else None


def is_phone(text: str, span: tuple[int, int, int]) -> bool:
    s, _, e = span
    digits = sum(c.isdigit() for c in text[s:e])
    return 10 <= digits <= 15 and (text[s - 1 : s] == "+" or bool(PHONE.fullmatch(text[s:e]) or CALLED.search(text[max(0, s - 24) : s])))


def seeds() -> list[str]:
    """Fixed texts with secrets, identifiers, cards, phones and other numbers."""
    out = []
    for i in range(60):
        h = hashlib.sha256(str(i).encode()).digest()
        b62 = "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[x % 62] for x in h)
        n = str(int.from_bytes(h[:8], "big") + 10**19)[-15:]
        card = next(n + c for c in "0123456789" if luhn(n + c))
        wrong = n + str((int(card[-1]) + 5) % 10)
        four = lambda x: " ".join(x[k : k + 4] for k in range(0, 16, 4))
        a, b, c = 200 + h[9] * 3, 200 + h[10] * 3, 1000 + h[11] * 30
        word = "".join("etaoinshrdlu"[x % 12] for x in h[: 17 + i % 9])
        out += [f"api key: {(b62, h.hex(), h[:20].hex(), b62[:20], 'sk_live_' + b62[:24])[i % 5]}, {word} {word[:9]}_{word[9:]}{i} {word[:6]}-{word[6:]}-20{i % 90 + 10}", f"paid {(card, four(card))[i % 2]}; order {('', wrong, four(wrong))[i % 3]}; on 20{i % 25:02}-{i % 12 + 1:02}-{i % 28 + 1:02}", f"call {(f'{a}-{b}-{c}', f'({a}) {b}-{c}', f'{a} {b} {c}', f'{a}.{b}.{c}', f'0{a} {b}{c}')[i % 5]} or +{i % 9 + 1} {a} {b} {c}, no. {c}{a}{i}"]
    return out


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 30, rate: float = 0.3) -> list[tuple]:
    """Depth-two trees by Newton steps on the logistic loss."""
    out, score = [], np.zeros(len(y))

    def leaf(rows):
        p = 1 / (1 + np.exp(-score[rows]))
        return float(rate * (y[rows] - p).sum() / ((p * (1 - p)).sum() + 1.0))

    def split(rows):
        p = 1 / (1 + np.exp(-score[rows]))
        g, h = y[rows] - p, p * (1 - p)
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
        tries = [(gain(m), f, float(t)) for f in range(x.shape[1]) for t in np.unique(np.quantile(x[rows, f], np.linspace(0.05, 0.95, 12))) if 0 < (m := x[rows, f] <= t).sum() < len(rows)]
        return max(tries)[1:] if tries else None

    for _ in range(trees):
        rows = np.arange(len(y))
        top = split(rows) if len(rows) > 1 else None
        if top is None:
            break
        tree = [top]
        for side in (rows[x[rows, top[0]] <= top[1]], rows[x[rows, top[0]] > top[1]]):
            sub = split(side) if len(side) > 1 else None
            parts = [side] if sub is None else [side[x[side, sub[0]] <= sub[1]], side[x[side, sub[0]] > sub[1]]]
            tree.append((sub, [leaf(r) for r in parts], parts))
        for _, values, parts in tree[1:]:
            for v, r in zip(values, parts, strict=True):
                score[r] += v
        out.append((top, *[(sub, values) for sub, values, _ in tree[1:]]))
    return out


def scored(model: list[tuple], row: list[float]) -> float:
    total = 0.0
    for top, low, high in model:
        sub, values = low if row[top[0]] <= top[1] else high
        total += values[0] if sub is None or row[sub[0]] <= sub[1] else values[1]
    return total


def labelled(texts: list[str], quota: int = QUOTA) -> dict[tuple[int, int], list[list[float]]]:
    """Features by kind and label, of the first ``quota`` candidates each.

    Base spans are no bar here: cards and phones among them are examples."""
    out: dict[tuple[int, int], list[list[float]]] = {(k, y): [] for k in (4, 5) for y in (0, 1)}
    for t in texts:
        for c in candidates(t, []):
            if (y := weak_label(t, c)) is not None and len(out[c[1], y]) < quota:
                out[c[1], y].append(described(t, c))
    return out


def fit(texts: list[str]) -> dict[int, dict]:
    given, fixed = labelled(texts), labelled(seeds())
    return {k: fit_kind([*fixed[k, 0], *given[k, 0]], [*fixed[k, 1], *given[k, 1]]) for k in (4, 5)}


def fit_kind(no: list[list[float]], yes: list[list[float]]) -> dict:
    order = np.random.default_rng(7).permutation(len(no) + len(yes))
    x, y = np.array(no + yes)[order], np.repeat([0.0, 1.0], [len(no), len(yes)])[order]
    held = np.arange(len(y)) % 4 == 3
    trees = boosted(x[~held], y[~held])
    s, y = np.array([scored(trees, r) for r in x[held].tolist()]), y[held]
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Platt's calibration on what the trees haven't seen
        p = 1 / (1 + np.exp(-(slope * s + shift)))
        slope += 0.5 * float(((y - p) * s).mean()) if len(s) else 0.0
        shift += 0.5 * float((y - p).mean()) if len(s) else 0.0
    return {"trees": trees, "slope": slope, "shift": shift, "doubt": 1 / (len(s) + 2)}


def probability(text: str, span: tuple[int, int, int], model: dict[int, dict]) -> float:
    """That the candidate is real: the odds of the trees times those of the evidence."""
    known, m = weak_label(text, span), model[span[1]]
    p = 1 / (1 + math.exp(-max(-50, min(50, m["slope"] * scored(m["trees"], described(text, span)) + m["shift"]))))
    p = min(max(p, m["doubt"]), 1 - m["doubt"])
    ratio = 1.0
    if known == 0:
        ratio = 1 / RATIO
    elif known and (KINDS[span[1]] == "secret" or is_phone(text, span)):
        ratio = RATIO
    elif known:
        p, ratio = max(0.0, (p - CHANCE) / (1 - CHANCE)), 1 / CHANCE
    return p * ratio / (p * ratio + 1 - p)


def spans_of(text: str, model: dict[int, dict], least: float = 0.8) -> tuple[list, list]:
    base = base_spans(text)
    more = [c for c in candidates(text, base) if probability(text, c, model) >= least]
    return sorted(base), sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def sampled_fit(docs: DataFrame, sample_docs: int) -> dict[int, dict]:
    """The model from at most ``sample_docs`` distinct texts, a third of each sort."""
    text, sorts = F.col("text"), {
        "named": r"(?i)(?:token|secret|key|password|passwd|pwd|auth)\s*[=:]\s*[\"']?[a-z0-9_\-]{16}|\b(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_)[a-z0-9_\-]{10}",
        "numbers": r"[0-9][0-9 ().-]{7}",
        "words": r"[A-Za-z0-9_\-]{16}",
    }
    flags = docs.where(text.rlike(f"{sorts['numbers']}|{sorts['words']}")).select(F.xxhash64("text").alias("h"), *(text.rlike(r).alias(k) for k, r in sorts.items()))
    flags = written(flags.distinct(), "pii-sorts")
    some = {r.h for k in sorts for r in flags.where(k).orderBy("h").limit(sample_docs // 3).select("h").collect()}
    if not some:
        return fit([])
    rows = docs.where(F.xxhash64("text").isin(sorted(some))).select(F.xxhash64("text").alias("h"), "text").groupBy("h").agg(F.min("text").alias("text")).collect()
    return fit([r.text for r in sorted(rows, key=lambda r: r.h)])


def personal_data(docs: DataFrame, sample_docs: int = 300) -> DataFrame:
    small_batches(docs.sparkSession)
    model = sampled_fit(docs, sample_docs)

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc_id, raw in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                base, every = spans_of(raw.decode("utf-8", "replace"), model)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                for o, v in zip(out, (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64() if i < 5 else pa.string()) for i, o in enumerate(out)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, model: dict[int, dict]) -> str:
    out, at = [], 0
    for s, k, e in spans_of(text, model)[1]:
        if e > at:
            out += [text[at : max(at, s)], f"<{KINDS[k]}>"]
            at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, sample_docs: int = 300) -> DataFrame:
    """``docs`` with each selected span of ``text`` replaced by its kind."""
    small_batches(docs.sparkSession)
    model, at = sampled_fit(docs, sample_docs), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redacted(t, model) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
