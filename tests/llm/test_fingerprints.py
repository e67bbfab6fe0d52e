import hashlib
import random
import re

import numpy as np
import zstandard

from waymark.llm import common, fingerprints
from waymark.llm.ngram_join import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def varied(prose):
    docs, r = [], random.Random(3)
    for g in range(30):  # copies with more and more changed words
        words = prose(100 + g, 80 + g).split()
        for k in range(6):
            docs.append((r.randrange(10**6) * 100 + len(docs), " ".join("x" if (j * 7 + k) % 97 < k // 2 else w for j, w in enumerate(words)), None, None, None))
    return docs


def test_rows(spark, folder, prose, odd):
    docs = varied(prose) + [d for d in odd if d[0] != 3] + [(3, prose(1, 40), "en", "a", 1)] * 2
    rows = fingerprints.op11_fingerprints(spark, folder(extra=True, documents=docs)).collect()
    own = lambda t: fingerprints.fingerprint(fingerprints.signature(shingles(t))).hex()
    ordered = sorted(((i, t or "") for i, t, *_ in docs), key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own(t), own(changed), round(fingerprints.likeness(bytes.fromhex(own(t)), bytes.fromhex(own(changed))), 9), round(fingerprints.likeness(bytes.fromhex(own(t)), bytes.fromhex(own(following))), 9)))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, rows)), key=str) == sorted(want, key=str)


def test_classes_against_brute_force(spark, folder, prose, odd):
    docs = varied(prose) + list(odd)
    rows = fingerprints.op11_fingerprints(spark, folder(documents=docs)).collect()
    found, group = [sets(t) for _, t, *_ in docs], list(range(len(docs)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if found[a] and found[b] and 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b]):
                group[find(a)] = find(b)
    lowest = {}
    for k, (i, *_) in enumerate(docs):
        lowest[find(k)] = min((x for x in (lowest.get(find(k)), i) if x is not None), default=None)
    want = [(i, lowest[find(k)] if found[k] else i) for k, (i, *_) in enumerate(docs)]
    assert sorted(((r["doc_id"], r["class_id"]) for r in rows), key=str) == sorted(want, key=str)


def test_no_link_is_lost_among_many_alike(spark, folder, prose):
    """Pairs over the threshold among texts below it, with which they share most of their bands."""
    base, docs = prose(900, 300).split(), []
    for k in range(300):
        words = list(base)
        words[random.Random(k // 2).randrange(300)] = f"p{k // 2}"
        for j in random.Random(1000 + k).sample(range(300), 3):
            words[j] = f"q{k}"
        docs.append((k, " ".join(words), None, None, None))
    found = [sets(t) for _, t, *_ in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])]
    assert len(links) > 40
    classes = {r["doc_id"]: r["class_id"] for r in fingerprints.op11_fingerprints(spark, folder(documents=docs)).collect()}
    assert [(a, b) for a, b in links if classes[a] != classes[b]] == []


def test_likeness_estimates_jaccard(prose):
    print_of = lambda t: fingerprints.fingerprint(fingerprints.signature(shingles(t)))
    errors = []
    for seed in range(60):
        a = prose(seed, 300).split()
        b = a[: 300 - 5 * seed] + prose(1000 + seed, 5 * seed).split()
        errors.append(fingerprints.likeness(print_of(" ".join(a)), print_of(" ".join(b))) - jaccard(sets(" ".join(a)), sets(" ".join(b))))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    assert fingerprints.likeness(print_of("a b"), print_of("A  b")) == 1 and print_of("") == print_of(" \n") and fingerprints.likeness(print_of(""), print_of("a")) < 0.05


def test_long_sets_in_blocks(prose, monkeypatch):
    found = shingles(prose(4, 5000))
    whole = fingerprints.signature(found)
    monkeypatch.setattr(fingerprints, "AT_ONCE", 7)
    assert (fingerprints.signature(found) == whole).all()
    naive = [min((int(a) * int(x) + int(b)) % 2**64 for x in found[:200]) for a, b in zip(fingerprints._FACTOR[:5, 0], fingerprints._SHIFT[:5, 0])]
    assert [int(x) for x in fingerprints.signature(found[:200])[:5]] == naive


def test_edited_form_is_not_hashed_anew(prose, monkeypatch):
    """Words that stay are hashed once for both forms, wherever the cut falls; the fingerprints are those of whole texts."""
    pack, own = zstandard.ZstdCompressor().compress, lambda t: fingerprints.fingerprint(fingerprints.signature(shingles(t)))
    cases = ["", "a", "a b c d", "a b c d e", "a b c d e f g h", "aa bb cc dd ee ff        ", "A b\x0bc d \u00e9\u00e9\u00e9\u00e9\u00e9\u00e9 \u6587\u5b57 e f g", "x" * 40, " " * 40, "a b c d e " * 40, *[prose(k, 5 + k) for k in range(30)], "    ", "\u3000" * 9]
    for a in cases:
        for b in cases:
            told = fingerprints._Row(1, 1, pack(a.encode())).told(fingerprints._Row(2, 2, pack(b.encode())))
            assert (told["fingerprint"], told["edited_fingerprint"]) == (own(a), own(fingerprints.edited(a, b))), (a, b)
    sizes, whole, following = [], prose(1, 4000), prose(2, 4000)
    rows = [fingerprints._Row(k, k, pack(t.encode())) for k, t in enumerate((whole, following))]
    hashed = fingerprints.signature
    monkeypatch.setattr(fingerprints, "signature", lambda found: sizes.append(len(found)) or hashed(found))
    rows[0].told(rows[1])
    assert sum(sizes) < 0.4 * len(shingles(whole))


def test_nothing_and_one(spark, folder):
    assert fingerprints.op11_fingerprints(spark, folder(documents=[])).collect() == []
    (row,) = fingerprints.op11_fingerprints(spark, folder(documents=[(None, "abcdefgh", None, None, 0)])).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """One key holds half of all rows; no task gets more than a few parts of it."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 0, id) AS k", "id")
    found = spark.range(4000).selectExpr("id AS k", "id * 10 AS v")
    joined = common.looked_up(rows, found, "k", rows["id"])
    assert {(r.k, r.id, r.v) for r in joined.collect()} == {(0 if i % 2 == 0 else i, i, 0 if i % 2 == 0 else 10 * i) for i in range(4000)}
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(name, value)
    try:
        sizes = common.looked_up(rows, found, "k", rows["id"]).groupBy(common.F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 2000 and sum(r["count"] for r in sizes) == 4000
