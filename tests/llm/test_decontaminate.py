import hashlib
import random
import subprocess
import sys

from epochal.llm.decontaminate import Automata, contamination, decontaminated, hit_spans, scan_words, words_of


def brute(text, items):
    words, hit, found = words_of((text or "").encode()), set(), set()
    for item, t in items:
        w = words_of((t or "").encode())
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[i : i + n]:
                    hit.update(range(k, k + n))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "B", "cé", "d9", "e"]
    items = [(str(i), " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 9, 10, 11, 25])))) for i in range(25) if i != 4] + [("n", None)]
    docs = [(0, None, 1), (1, "", 1)]
    for i in range(2, 60):
        pick = rng.choice(items)[1] or ""
        docs.append((i % 50, " ".join(rng.choices(vocab, k=rng.randrange(30))) + "; " + pick + "\n" + " ".join(rng.choices(vocab, k=12)), 2))
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    for block in (10**6, 40):
        got = contamination(df, items, block_words=block).collect()
        assert sorted(tuple(r)[1:] for r in got) == sorted(brute(t, items) for _, t, _ in docs)
    bench = spark.createDataFrame([*items, (None, "q r s")], "item_id string, text string")
    more = spark.createDataFrame([*docs, (99, "x q R, s", 0)], df.schema)
    got = hit_spans(more, bench, most_bytes=150).drop("spans").collect()  # several groups
    assert sorted(tuple(r)[1:] for r in got) == sorted(brute(t, [*items, ("", "q r s")]) for t in [t for _, t, _ in docs] + ["x q R, s"])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert contamination(df, []).count() == 0


def test_spans_are_cut_and_only_covered_documents_dropped(spark):
    rng = random.Random(4)
    word = lambda: "w" + "".join(rng.choices("abcdefgh", k=6))
    item, clean = [word() for _ in range(14)], [word() for _ in range(200)]
    long = " ".join(clean[:100]) + " É" + "! " + ", ".join(x.upper() for x in item[:12]) + ". É " + " ".join(clean[100:])
    nested = " ".join(clean[:50] + item[:5] + item[2:14] + item[5:] + clean[50:])
    docs = [(1, long, 9), (2, " ".join(item), 9), (3, None, 9), (4, "", 9), (5, "x two words y z q", 9), (6, nested, 9), (1, long, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, extra int")
    items = [("a", " ".join(item)), ("b", "two words")]
    rows = decontaminated(df, items).collect()
    got = {r.doc_id: r.text for r in rows}
    assert len(rows) == 6 and set(got) == {1, 3, 4, 5, 6} and rows[0].extra == 9
    assert got[1] == " ".join(clean[:100]) + " É! . É " + " ".join(clean[100:])
    assert (got[3], got[4], got[5]) == (None, "", "x  y z q")
    assert got[6].split()[:50] == clean[:50] and got[6].split()[-150:] == clean[50:]
    left = decontaminated(df, items).select("doc_id", "text")
    assert not any(r.contaminated for r in contamination(left, items).collect())
    spans = {r.doc_id: (r.spans, r.n_hit) for r in hit_spans(df, items).collect()}
    assert spans[1] == ("101:113", 12) and spans[2] == ("0:14", 14) and spans[5] == ("1:3", 2)


def test_random_texts_lose_all_spans_in_groups_too(spark):
    rng = random.Random(9)
    items = [(str(i), " ".join(rng.choices("abc", k=rng.choice([3, 10, 12])))) for i in range(6)]
    docs = [(i, " ".join(rng.choices("abcdefgh", k=40)) + " " + rng.choice(items)[1] + " " + " ".join(rng.choices("abcdefgh", k=40))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for most in (10**6, 20):
        left = decontaminated(df, bench, most_coverage=1.0, most_bytes=most)
        assert not any(r.contaminated for r in contamination(left, items).collect()) and left.count() == 40


def test_a_long_text(spark):
    rng = random.Random(2)
    text = " ".join(rng.choices([f"w{i}" for i in range(2000)], k=400_000))
    item = " ".join(text.split()[1000:1020])
    (row,) = hit_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), [("a", item)]).collect()
    assert (row.n_words, row.n_hit, row.spans) == (400_000, 20, "1000:1020")


def test_packed_automata_without_spark():
    rng = random.Random(8)
    for _ in range(300):
        items = [(str(i), " ".join(rng.choices("abcd", k=rng.choice([0, 1, 3, 4, 5, 10, 11, 14])))) for i in range(rng.randrange(5))]
        automata = Automata(items, 10, rng.choice([1, 12, 1000]))
        for _ in range(4):
            text = " ".join(rng.choices("abcdx", k=rng.randrange(40)))
            spans, found = scan_words(automata, words_of(text.encode()))
            n_words, n_hit, n_items, names, hit = brute(text, items)
            assert (sum(e - s for s, e in spans), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()) == (n_hit, n_items, names)


def test_automata_of_random_words_stay_small():
    """8 MB of items take less than 130 MB and what one block needs while it is made."""
    code = """
import random, resource
from epochal.llm.decontaminate import Automata
rng = random.Random(1)
items = [(str(i), " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(100))) for i in range(13400)]
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
automata = Automata(items, 10, 100_000)
print(peak() - before, len(automata.blocks))
"""
    took, blocks = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert float(took) < 250 and int(blocks) == 14
