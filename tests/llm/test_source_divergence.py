import re
from collections import Counter, defaultdict

from waymark.llm import source_divergence as sd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(docs, least, most=50):
    """Dense counts over all kept terms, as the contract says it."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        own = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(own)
        seen[lang].update(set(own))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]

        def parts(tally, kept=kept):
            total = sum(tally[t] for t in kept)
            return {t: 1 + 10**9 * (tally[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = parts(counts[lang, source])
        whole = parts(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = [(other, sum(abs(own[t] - q) for t, q in parts(counts[lang, other]).items())) for x, other in groups if x == lang and other != source]
        terms = [(t, own[t] - whole[t]) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, rows, last in (("pair", pairs, None), ("term", terms, most)):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(rows[:last])]
    return sorted(out)


def made(prose, odd):
    docs = list(odd)
    for k in range(150):
        stems = (("ta", "RI", "mon"), ("ta", "él", "日"), ("ri", "ka", "Ss"))[k % 3]
        docs.append((100 + k, prose(k, 40 + k, stems), ("en", "de", None)[k % 3 if k % 5 else 0], f"s{k % 4}" if k % 7 else None, 0))
    docs += [(900 + k, "tie b tie-B c_d e2f ÀÉ àé  x\x7fy", "en", f"t{k % 2}", 0) for k in range(40)]
    return docs + [(990, None, "en", "empty", 0), (991, "12 ?", "xx", "a", 0), (992, "y", "xx", "b", 0)]


def test_against_dense_counts(spark, folder, prose, odd, monkeypatch):
    docs = made(prose, odd)
    got = sd.op12_source_divergence(spark, folder(extra=True, documents=docs)).collect()
    want = expected(docs, 30)
    assert sorted(map(tuple, got)) == want
    assert max(r[5] for r in want if r[2] == "term") > 10 and any(r[4] == 0 and r[2] == "pair" for r in want)
    monkeypatch.setattr(sd, "HELD_TERMS", 3)  # sums that are sent again and again
    few = sd.divergence(spark.read.parquet(folder(documents=docs) + "/documents.parquet"), least=3, most=7).collect()
    assert sorted(map(tuple, few)) == expected(docs, 3, 7)


def test_nothing(spark, folder):
    assert sd.op12_source_divergence(spark, folder(documents=[])).collect() == []
    lone = sd.op12_source_divergence(spark, folder(documents=[(1, "a", None, None, 0), (2, "b", None, "x", 0)])).collect()
    assert sorted(map(tuple, lone)) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_table_of_bytes():
    assert sd.terms("Ab1c É'é Z_z\x7f日本".encode()) == ["ab".encode(), b"c", "É".encode(), "é".encode(), b"z", b"z", "日本".encode()]
