import random

from epochal.llm.licenses import TEMPLATES, WORD, license_spans, winnow, Scanner


def filler(rng, n):
    return " ".join("".join(rng.choices("bcdfgaeiou", k=rng.randrange(3, 9))) for _ in range(n))


def brute(text):
    """Exact occurrences of whole templates, longest first, without overlaps."""
    words = [(m.group(), *m.span()) for m in WORD.finditer(text.lower())]
    found = []
    for name, t in TEMPLATES:
        own = WORD.findall(t.lower())
        for i in range(len(words) - len(own) + 1):
            if [w[0] for w in words[i : i + len(own)]] == own:
                found.append((-len(own), name, words[i][1], words[i + len(own) - 1][2]))
    kept = []
    for f in sorted(found):
        if all(f[3] <= g[2] or f[2] >= g[3] for g in kept):
            kept.append(f)
    return sorted((s, e, n) for _, n, s, e in kept)


def test_exact_notices_match_brute_force(spark):
    rng = random.Random(6)
    docs = [(0, None), (1, ""), (2, "MIT"), (3, "Licensed")]
    for i in range(60):
        parts = [filler(rng, rng.randrange(40)) for _ in range(4)]
        for k in range(i % 4):
            parts[k] += "\n" + rng.choice(TEMPLATES)[1].upper() + "\n"
        docs.append((4 + i // 2, " ".join(parts)))
    df = spark.createDataFrame([(*d, [1]) for d in docs], "doc_id long, text string, spans array<int>")
    got = sorted((r.doc_id, [(s.start, s.end, s.license) for s in r.spans]) for r in license_spans(df).collect())
    assert got == sorted((i, brute(t or "")) for i, t in docs)
    assert license_spans(df.where("false")).count() == 0


def test_changed_notices_report_coverage():
    scan = Scanner(TEMPLATES, 3, 3, 8, 0.8)
    rng = random.Random(7)
    for name, t in TEMPLATES:
        words = t.split()
        if len(words) < 25:
            continue
        for k in rng.sample(range(1, len(words) - 1), 3):
            words[k] = "changedword"
        del words[len(words) // 2]
        text = filler(rng, 30) + " " + " ".join(words) + " " + filler(rng, 30)
        (span,) = scan.spans(text)
        assert span[2] == name and 0.8 <= span[4] < 1
        assert text[span[0] : span[1]] == " ".join(words).strip("()./")
    assert scan.spans(filler(rng, 3000)) == []


def test_five_shared_words_share_a_fingerprint():
    rng = random.Random(8)
    scan = Scanner([], 3, 3, 8, 0.8)
    for _ in range(300):
        run = filler(rng, 5).split()
        a, b = ([*filler(rng, rng.randrange(9)).split(), *run, *filler(rng, rng.randrange(9)).split()] for _ in range(2))
        assert set(winnow(scan.hashes(a), 3, 3)[1].tolist()) & set(winnow(scan.hashes(b), 3, 3)[1].tolist())


def test_partial_notices_are_told_apart():
    scan = Scanner(TEMPLATES, 3, 3, 8, 0.8)
    rng = random.Random(9)
    for name, t in TEMPLATES:
        words = t.split()
        if len(words) >= 60:
            half = " ".join(words[: len(words) // 2])
            (span,) = scan.spans(f"{filler(rng, 20)} {half} {filler(rng, 20)}")
            shorter = any(" ".join(WORD.findall(x.lower())) in " ".join(WORD.findall(half.lower())) for _, x in TEMPLATES)
            assert span[2] == name and (span[5] if shorter else 0.3 < span[4] < 0.8 and not span[5]), span
            assert all(s[5] for s in scan.spans(f"{filler(rng, 20)} {t} {filler(rng, 20)}"))
