import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corvane.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        n = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}
        share = lambda c, kept=kept: {t: 1 + 10**9 * (k + 5) // (sum(c.values()) + 5 * len(kept)) for t, k in c.items()}
        p, q = {s: share(n[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_rows_of_every_kind(docs, held, none):
    for least, most in ((1, 50), (2, 3), (30, 50)):
        assert got(divergence.audit(docs, least, most)) == brute(held, least, most)
    assert divergence.audit(none).collect() == []


def test_random_texts_and_small_sums(spark, monkeypatch):
    r = random.Random(4)
    words = ["Straße", "straße", "STRASSE", "日本", "été", "É", "a", "B", "b", "x-y", "don't", "😀", "q1q", "", " ", "Zz_Zz"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 12))), r.choice(["en", "de", None, ""]), r.choice(["s", "S", "ß", None, "", "t"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    want = brute(rows, 5, 4)
    assert got(divergence.audit(docs, 5, 4)) == want
    monkeypatch.setattr(divergence, "HELD", 3)  # sums handed on again and again
    counts = divergence.term_counts(docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]), held=3)
    whole = Counter()
    for row in counts.collect():
        whole[row.term.decode()] += row.n
    assert whole == Counter(t for x in rows for t in TERM.findall(x[1].translate(LOWER)))
    monkeypatch.setattr(divergence, "MOST_BYTES", 0)  # without the broadcast
    assert got(divergence.audit(docs, 5, 4)) == want


def test_shares_are_exact_far_beyond_what_a_product_holds(spark):
    r = random.Random(9)
    rows = [(n := r.randint(0, 10 ** r.randint(1, 15)), n + r.randint(0, 10 ** r.randint(1, 15)), r.randint(1, 10**6)) for _ in range(300)]
    df = spark.createDataFrame(rows, "n long, total long, kept long").select("n", "total", "kept", divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    assert all(x.p == 1 + 10**9 * (x.n + 5) // (x.total + 5 * x.kept) for x in df.collect())
